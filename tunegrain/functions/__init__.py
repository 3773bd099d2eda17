"""Column-to-column building blocks; everything here stays inside Catalyst expressions."""
