"""Plan helpers shared by the operators: written tables and session defaults."""
