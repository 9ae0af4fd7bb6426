"""Model jobs: design columns, fits from aggregated statistics, draws and checks."""
