"""Looking at plans and runs."""
