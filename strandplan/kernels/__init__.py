"""Pure Python search kernels run inside one task per independent group."""
