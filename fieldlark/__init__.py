"""Sports-analytics operators as DataFrame functions and column expressions."""
