"""DataFrame -> DataFrame analysis operators."""
