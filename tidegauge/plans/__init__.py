"""Resolution, planning and execution of parsed operations."""
