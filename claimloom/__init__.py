"""claimloom: claim verification and evaluation as Spark DataFrame plans."""
