"""Where pages, dictionaries and models come from."""
