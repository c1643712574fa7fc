"""Reading documents, uploads and gold; writing reports."""
