"""Reading catalogues, and write-once outputs."""
