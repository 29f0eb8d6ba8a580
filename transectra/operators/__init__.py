"""DataFrame-in, DataFrame-out operators; all lazy unless their docstring says otherwise."""
