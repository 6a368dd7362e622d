"""quillspark: a PySpark library for collaborative-editing histories."""
