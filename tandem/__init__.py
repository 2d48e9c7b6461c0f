"""tandem: DataFrame jobs for building and scoring two-dialect code translation sets."""
