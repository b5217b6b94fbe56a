"""The lake, CSV drops and document publishing."""
