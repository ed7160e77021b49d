"""tillroll: sales analytics on Spark.

Star schema (orders, order_items, customers, products), file ingest with
validation and load audit, the standard sales queries, and the BI metric
layer above them, all expressed as DataFrame / SQL plans.
"""

__version__ = "0.1.0"
