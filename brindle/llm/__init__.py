"""Training-data pipeline operators: ten corpus operators, their registered queries and SQL.

Nothing else in the package imports this subpackage.
"""
