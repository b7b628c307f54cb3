"""keratoline: clinical measurement analytics expressed as Spark plans."""
