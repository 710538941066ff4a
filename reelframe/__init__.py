"""Video-corpus evaluation and annotation tables as PySpark DataFrame functions."""
