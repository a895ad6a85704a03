"""ledgerlink: record-linkage analytics as Spark DataFrame plans."""
