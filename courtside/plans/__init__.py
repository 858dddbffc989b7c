"""The operators bound to the driver's tables, with the SQL each must agree with."""
