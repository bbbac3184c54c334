"""Live queries: deltas between snapshots, and the change log as a stream."""
