"""Tables in and out, and code lists."""
