"""msgflow: understanding, answering and routing text messages with Spark.

Messages are a table or a stream.  Every operator is a function from DataFrame
to DataFrame, or a builder of Column expressions; nothing here depends on the
order or the partitioning of its input.
"""

__version__ = "0.1.0"
