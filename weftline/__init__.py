"""weftline: record linkage, text normalisation and table clean-up as Spark plans."""
