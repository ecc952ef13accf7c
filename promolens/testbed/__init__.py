"""The driver's tables bound to the library's frames, and the queries run over them."""
