"""Every operator bound to the test tables, and the SQL each one is checked against."""
