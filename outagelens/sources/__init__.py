"""Sources and sinks: loaders with explicit schemas, fixture adapters, snapshots."""
