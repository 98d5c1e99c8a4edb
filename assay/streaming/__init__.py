"""Live forms of the log and manifest operators."""
