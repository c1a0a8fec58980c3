"""Column functions: values, identities, prose and vectors. Nothing here needs a Python worker."""
