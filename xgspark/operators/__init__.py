"""DataFrame -> DataFrame operators of the inventory."""
