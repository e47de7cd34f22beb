"""Sources and sinks: archives as tables, text formats."""
