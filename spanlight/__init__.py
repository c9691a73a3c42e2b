"""spanlight: source-observability analytics as DataFrame-to-DataFrame operators."""
