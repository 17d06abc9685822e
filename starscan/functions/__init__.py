"""Expression builders. Unless noted otherwise they take and return SQL expression text, to be
used with ``selectExpr`` or ``functions.expr``: one parse instead of many driver round trips."""
