"""Network descriptions: parsing, defaults, layer lists and sizes."""
