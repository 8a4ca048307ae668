"""tessera: catalog-reconciliation operators on PySpark DataFrames."""
