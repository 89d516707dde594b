"""propgraph: property graphs and large-table data processing on PySpark DataFrames."""
