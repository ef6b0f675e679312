"""Column builders shared by sources and plans."""
