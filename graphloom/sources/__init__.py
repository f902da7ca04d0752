"""Where graphs come from: tables, and packed binary edge files."""
