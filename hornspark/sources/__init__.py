"""Outside relations: tables that Spark reads, fact files, JSON, and their fingerprints."""
