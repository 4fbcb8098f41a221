"""crateforge: catalogue reconciliation analytics as Spark plans."""
