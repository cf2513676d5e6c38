"""The reports bound to the sample tables, with SQL that checks them."""
