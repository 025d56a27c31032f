"""Column-parameterised DataFrame operators shared by all reports."""
