"""How space is divided: the grid partition plan and the box tree below it."""
