"""tapewell: social attention, sentiment and volatility analytics on Spark.

Everything is a function from DataFrames to DataFrames. Sub-packages:

``sources``/``sinks``  readers and writers
``functions``          scalar column expressions
``operators``          relational building blocks (text, joins, windows, rolling totals ...)
``plans``              whole pipelines put together from operators
``estimators``         fixed-effects regression, GARCH-X, mean group, likelihood-ratio tests
``scoring``            score tables and injected text scorers
``streaming``          structured streaming variants
``queries``            the named queries with their SQL twins
``llm``                operators for training-data preparation; nothing else imports it
"""

__version__ = "0.1.0"
