"""embdrift: embedding and text drift analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames to a DataFrame.  Nothing is
collected to the driver except one-row results (counts, a baseline id);
vector kernels run inside Arrow batches only where no SQL expression exists.
"""

__version__ = "0.1.0"
