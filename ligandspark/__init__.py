"""ligandspark package."""
