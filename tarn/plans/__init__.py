"""Rule plans, maintenance plans and the registered queries."""
