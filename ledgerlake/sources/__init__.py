"""The change log and its storage layout."""
