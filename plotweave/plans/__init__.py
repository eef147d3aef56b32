"""Plan building blocks that stay balanced when one key holds most of the rows."""
