"""Query declarations: the 29-statement catalogue and the aggregate-once workbench."""
