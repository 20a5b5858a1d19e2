"""Training-data operators: each works on whole tables and keeps its own general interface."""
