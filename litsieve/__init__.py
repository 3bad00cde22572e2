"""Record screening and corpus curation as Spark DataFrame plans."""
