"""Model clients and the operator that maps prompts to responses."""
