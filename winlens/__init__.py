"""winlens: packet-window detection and incident analytics as Spark DataFrame transforms."""
