"""Part of dataplumb; see its modules."""
