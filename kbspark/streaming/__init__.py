"""The same steps over streams of new rows."""
