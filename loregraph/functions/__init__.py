"""Column-level building blocks (all JVM-side unless a module says otherwise)."""
