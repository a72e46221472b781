"""Job control: tags that cancel a running query."""
