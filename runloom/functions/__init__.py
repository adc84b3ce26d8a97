"""Column expressions and plan-time name rules."""
