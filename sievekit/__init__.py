"""sievekit: near-duplicate removal and diverse-subset selection on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a Column
builder); the plans live in Catalyst, the iterative parts are short driver
loops over DataFrames whose per-round state is written to the checkpoint
directory named by ``spark.checkpoint.dir``.
"""

__version__ = "0.1.0"
