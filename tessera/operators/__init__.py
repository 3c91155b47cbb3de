"""Matrix operators over CELLS / ROWS / BLOCKS DataFrames."""
