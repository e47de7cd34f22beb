"""The query catalogue over the driver's tables, with equivalent SQL."""
