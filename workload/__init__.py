"""The registered queries: every operator over whole tables, each beside its SQL."""
