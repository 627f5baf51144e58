"""Three small languages, compiled to Column and DataFrame plans."""
