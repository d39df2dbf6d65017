"""Cohort, phenotype, exposure, measurement, outcome, rate and survival plans."""
