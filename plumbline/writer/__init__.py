"""Writing a planned reconciliation into files: driver-side by nature, as it must keep every other byte."""
