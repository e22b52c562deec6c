"""Sources and sinks: driver tables, tracker JSON, file listings, schema
detection and capacity snapshots."""
