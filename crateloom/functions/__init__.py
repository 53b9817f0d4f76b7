"""Column -> Column rules; everything here stays inside Catalyst."""
