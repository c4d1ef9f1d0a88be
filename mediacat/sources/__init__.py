"""Reading exports and writing catalog tables."""
