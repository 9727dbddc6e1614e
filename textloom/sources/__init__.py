"""Where documents, logs and packed rows come from and where they go."""
