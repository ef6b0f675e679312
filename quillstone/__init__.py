"""quillstone: a Spark-native engine for investment ledgers and the analytics over them."""
