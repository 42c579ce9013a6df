"""docsheet: document, spreadsheet and training-data analytics on PySpark."""
