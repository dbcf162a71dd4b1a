"""Column expressions shared by the batch and streaming jobs. All are built-in
Spark expressions; none needs a Python function on the executors."""
