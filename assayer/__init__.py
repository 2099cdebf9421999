"""DataFrame operators for evaluating model runs over nested documents and session logs."""
