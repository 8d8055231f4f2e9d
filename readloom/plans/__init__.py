"""Relations made from the driver's tables, and plans built on them."""
