"""Spark SQL expressions as text: rounding, geometry, grid cells, neighbour lists.

Every function takes and returns SQL text for ``selectExpr`` / ``where`` / ``F.expr``,
so a long formula reaches Spark in one piece.
"""
