"""Reading exports and writing them back in their layout."""
