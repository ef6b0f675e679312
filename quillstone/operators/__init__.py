"""DataFrame -> DataFrame operators; none collects rows or loops over them on the driver."""
