"""Where dumps come from and where they are kept."""
