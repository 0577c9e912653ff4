"""Sources and sinks: session logs, outline notes, chunk tables, JSON logs."""
