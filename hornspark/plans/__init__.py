"""From clauses to the order of evaluation: strata, safety, kinds, fixpoints."""
