"""Cohort analytics on Spark: keyed assembly under contracts, regional features,
ranking and performance statistics, shared resampling, prediction models and
spatial statistics, as DataFrame plans with NumPy kernels where no plan exists."""
