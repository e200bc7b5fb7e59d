"""Column functions: rounding, colour, device strategies and quantizers."""
